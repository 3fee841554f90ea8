"""Byte-level BPE by a local rank file: the ids that the tiktoken library gives, and their bytes again.

Long texts are cut at safe boundaries: places where every match of the splitting pattern ends, whatever stands around them.
A match of RUN characters or more, whose merging would take quadratic time, is merged here with a heap, by the same rule: least rank first, leftmost first.

Rules for odd input: a null text is empty and has no ids; repeated rows are encoded each; an empty table gives an empty
result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
RUN = 512
#: Before a line feed that follows a letter or digit and precedes a letter or digit, a match ends; so does one after that line feed.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=\n[\p{L}\p{N}])|(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])")


class Codec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.strings = [str(i) for i in range(max(self.ranks.values()) + 1)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match, in n log n time."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        start = list(range(n + 1))
        after, prior = list(range(1, n + 2)), list(range(-1, n))
        end = [i + 1 for i in range(n)]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                prior[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := prior[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]

    def _plain(self, text: str) -> bool:
        """True if no match can be long: told from the words' lengths and the white space between them, without the pattern."""
        words = text.split()
        return not words or (max(map(len, words)) < RUN and len(text) - sum(map(len, words)) - len(words) < RUN)

    def _part(self, text: str) -> list[int]:
        if len(text) < RUN or self._plain(text):
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        done = solid = 0  # where the part not yet encoded begins, and where its last match that isn't white space ends
        spaces: list[str] = []
        for m in self.pattern.finditer(text):
            if m.end() - m.start() >= RUN:
                if solid > done:
                    out += self.encoding.encode_ordinary(text[done:solid])
                for s in [*spaces, m[0]]:  # white space splits differently at the end of a text
                    out += self.merge(s.encode())
                done = solid = m.end()
                spaces = []
            elif m[0].isspace():
                spaces.append(m[0])
            else:
                solid, spaces = m.end(), []
        return out + (self.encoding.encode_ordinary(text[done:]) if done < len(text) else [])

    def encode(self, text: str) -> list[int]:
        if len(text) <= CHUNK:
            return self._part(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            m = SAFE.search(text, at + CHUNK) if at + CHUNK < len(text) else None
            end = m.start() if m else len(text)
            out += self._part(text[at:end])
            at = end
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with with_ids, the ids and the decoded bytes themselves."""

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows = []
                for raw in batch.column(1).to_pylist():
                    ids = own.encode(raw or "")
                    back = own.decode(ids)
                    joined = ",".join([own.strings[i] for i in ids]).encode()
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest(), ids if with_ids else None, back if with_ids else None))
                n, a, b, ids, back = zip(*rows, strict=True)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
