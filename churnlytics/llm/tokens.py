"""Token ids of whole texts with public byte-level vocabularies.

``byte_bpe_50k.tiktoken`` is the vocabulary of ``byte_bpe_50k.json`` as ranks;
tiktoken gives the same ids as the tokenizers library does with the JSON file
(special tokens as ordinary text), several times as fast. Texts that its
regular expression gives up on are split with the ``regex`` library instead.
"""

from __future__ import annotations


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """``encode(text) -> list of ids`` for a .tiktoken file of ranks."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = public_tokenizers.PATTERN
        self.bpe = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self._regex = None

    def encode(self, text: str) -> list[int]:
        try:
            return self.bpe.encode_ordinary(text)
        except BaseException as e:  # tiktoken panics where its pattern backtracks too far
            if type(e).__name__ != "PanicException" and not isinstance(e, (ValueError, RuntimeError)):
                raise
            return self._by_piece(text)

    def _by_piece(self, text: str) -> list[int]:
        if self._regex is None:
            import regex
            self._regex = regex.compile(self.pattern)
        out: list[int] = []
        for m in self._regex.finditer(text):
            out.extend(self.bpe._encode_single_piece(m[0].encode("utf-8")))
        return out
