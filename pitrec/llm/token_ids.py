"""The token ids that the `tokenizers` library gives for a byte-level BPE file.

Where the ids of a vocabulary follow its order of merges, a rank encoder over the same
bytes gives the same ids in a fraction of the time; it is built from the .json file
itself. Files for which that does not hold, and texts beyond LONG characters, go to
the library. Special strings in a text are handled as the library does by default.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .token_counts import PATTERN, _byte_alphabet

LONG = 1 << 20  # characters; a rank encoder's pattern search may run out of stack on longer ones


class TokenIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._ranks = self._encoder(spec)

    @staticmethod
    def _encoder(spec: dict):
        """None if the ids are not in the order of merges, or the file asks for what a rank encoder has not."""
        model, before, special = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocabulary, alphabet = model["vocab"], _byte_alphabet()
        plain = model["type"] == "BPE" and not model.get("dropout") and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in special)
        named = {x["content"] for x in special}
        ordered = plain and [vocabulary[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(vocabulary) - len(named & vocabulary.keys()) == 256 + len(merges)
        if not ordered:
            return None
        import tiktoken

        ranks = {bytes(alphabet[c] for c in token): k for token, k in vocabulary.items() if token not in named}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in special})

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, text: str) -> np.ndarray:
        if self._ranks is None or len(text) > LONG:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._ranks.encode_to_numpy(text, allowed_special="all")
