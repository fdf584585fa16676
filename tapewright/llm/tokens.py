"""Token ids of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

#: White space as the vocabulary's own splitting rule sees it (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

#: Parts that can be encoded one by one: a run of Latin letters or of ASCII marks where its right end is certain, else
#: all up to the next white space. Apostrophes may start a contraction, so runs beside them stay whole.
CHUNKS = re.compile(
    rf" ?[{_LETTERS}]++(?=[\x09-\x0d -&(-@\[-`{{-~]|\Z)| ?[!-&(-/:-@\[-`{{-~]++(?=[{_LETTERS}0-9\x09-\x0d ]|\Z)"
    rf"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


#: Longer chunks are encoded by the tokenizer library, whose merging stays fast on them.
LONG_CHUNK = 100


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes; each distinct chunk is encoded once while the cache lasts.

    Short chunks are merged by the rank table of the same vocabulary where it lies beside the vocabulary,
    which gives the same ids in less time.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.path, self.most, self.known, self.library = path, most, {}, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranks = _rank_encoding(ranks) if os.path.exists(ranks) else None

    def _encode(self, chunks: list[str]) -> Iterator[list[int]]:
        if self.ranks is not None and all(len(c) <= LONG_CHUNK for c in chunks):
            return map(self.ranks.encode_ordinary, chunks)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        return (e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False))

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            chunks = CHUNKS.findall(text)
            try:
                yield b"".join(map(self.known.__getitem__, chunks))
                continue
            except KeyError:
                pass
            if len(self.known) > self.most:
                self.known = {}
            new = [c for c in set(chunks) if c not in self.known]
            for c, ids in zip(new, self._encode(new)):
                self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
            yield b"".join(map(self.known.__getitem__, chunks))


def _rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
