"""Byte-pair tokenisers out of files of ranks."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

#: Folder of the public tokenizers' files, and the vocabulary used unless another is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoding(pattern: str, ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


class Tokenizer:
    """A byte-level BPE vocabulary with the pattern that splits text before the merges.

    Both are read where the object is made, that is by the driver, and travel with it: executors need not have the files. The
    encoder is built once a process. A vocabulary has a fixed size of a megabyte or so.
    """

    def __init__(self, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS):
        spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder) / "__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        self.pattern, self.ranks = module.PATTERN, (Path(folder) / vocabulary).read_bytes()

    @property
    def encoding(self):
        """The encoder, with ``encode_ordinary`` and ``decode``."""
        return _encoding(self.pattern, self.ranks)


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS):
    """The encoder of a vocabulary file, for use in this process."""
    return Tokenizer(vocabulary, folder).encoding
