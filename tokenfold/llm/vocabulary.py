"""A byte-level BPE vocabulary file as tasks use it: opened once per Python worker."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

import public_tokenizers

#: Code points whose letter, number and space classes the libraries have agreed on for long.
#: A text with any other one takes the tokenizers library's own word splitting.
SETTLED = (
    (0x0000, 0x0557), (0x0620, 0x0657), (0x0900, 0x0977), (0x0E00, 0x0E5B), (0x1E00, 0x1FFE),
    (0x2010, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x218B), (0x2190, 0x23FF), (0x2500, 0x27FF),
    (0x3000, 0x303F), (0x3041, 0x3096), (0x30A0, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
    (0xFF00, 0xFFEF), (0x1F300, 0x1F64F),
)

#: White space by Unicode's property, as a character class that every regex engine reads alike.
SPACES = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: The byte-level word pattern, with white space spelt out (a fixed value).
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def java_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """Ranges of code points as the inside of a Java character class."""
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def python_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokenizer file ``path``; the instances of one Python worker share what is loaded."""

    def __init__(self, path: str):
        self.path = path

    @property
    def tokenizer(self):
        return _tokenizer(self.path)

    @cached_property
    def specials(self) -> list[str]:
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @property
    def longest_special(self) -> int:
        return max(map(len, self.specials), default=0)

    def pieces(self) -> list[bytes]:
        """The bytes of each id, by id; ids without a token are empty. Special tokens stand for their text."""
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out = [b""] * (max([*vocab.values(), *added], default=-1) + 1)
        for token, i in vocab.items():
            out[i] = bytes(alphabet[c] for c in token)
        for i, content in added.items():
            out[i] = content
        return out

    def counter(self) -> Callable[[str], int]:
        """Counts a whole text's tokens: by the byte-rank encoder where both are proven alike, else by tokenizers."""
        import re

        odd = re.compile("|".join([f"[^{python_class(SETTLED)}]", *map(re.escape, self.specials)]))
        tokenizer, fast = self.tokenizer, _ranked(self.path)

        def count(text: str) -> int:
            if odd.search(text):
                return len(tokenizer.encode(text, add_special_tokens=False))
            return len(fast.encode_ordinary(text))

        return count


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The same vocabulary as ranked byte strings: a merge's rank is that of the token it makes."""
    import tiktoken

    vocabulary = Vocabulary(path)
    specials = {s.encode() for s in vocabulary.specials}
    ranks = {p: i for i, p in enumerate(vocabulary.pieces()) if p and p not in specials}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
