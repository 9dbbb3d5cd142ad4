"""Byte-level BPE ids of whole texts, the same as the tokenizers library gives.

The rank file holds the vocabulary of the JSON file; tiktoken reads it and is several times faster. Texts that hold the
string of an added token of the JSON file go through the tokenizers library, which gives that token's id, and so do texts with very long runs of white space.
`encode_ordinary` knows no added tokens: their strings are text like any other.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np


# The fast library's pattern search overflows on very long runs of white space.
_LONG_SPACE = re.compile(r"\s{1000}")


class ByteBpe:
    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._slow, self._plain = json_path, None, None

    @property
    def slow(self):
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow

    @property
    def plain(self):
        """The library's tokenizer without the added tokens."""
        if self._plain is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            with open(self.json_path, encoding="utf-8") as f:
                self._plain = Tokenizer.from_str(json.dumps(json.load(f) | {"added_tokens": []}))
        return self._plain

    def encode_ordinary(self, text: str) -> np.ndarray:
        if len(text) > 4096 and _LONG_SPACE.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added) or len(text) > 4096 and _LONG_SPACE.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)
