"""Token ids of whole texts by a public byte-level BPE vocabulary.

The tokenizer file says what the ids are. Its library keeps alignments that ids
alone do not need; where a rank file of the same vocabulary is given, ordinary
texts are merged from the ranks instead, several times as fast, with the same
ids. Texts that hold the string of an added token go to the tokenizer.
"""

from __future__ import annotations

import base64
import os

import numpy as np


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.merges is None or any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.merges.encode_ordinary(text)
        return np.array(ids, self.dtype).tobytes()
