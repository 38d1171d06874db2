"""Token ids of texts by a public tokenizer, with a bounded memory of what was encoded before.

Both public vocabularies encode pieces of a text apart from each other, so
each distinct piece goes through the tokenizer once and texts are put together
from the remembered ids. Texts of ASCII and the usual Latin letters are cut
with the vocabulary's own splitting pattern written for those letters; other
texts with the pattern in full (byte level) or at ASCII white space (words).
New pieces are encoded many to a call, joined so that they stay apart; where
the ids cannot be told apart again, each piece gets a call of its own. A text
in which a special token's string occurs is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

# The splitting patterns of the vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters for which upper and lower case, composition and classes are plain.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: ASCII without the separators 1C to 1F, which patterns disagree on.
PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7e{LATIN}]*")
REMEMBER = 800_000
TOGETHER = 512


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "[0-9]").replace("[^\\s\\p{L}\\p{N}]", f"[^\\s0-9{LATIN}]").replace("\\p{L}", f"[{LATIN}]").replace("\\p{N}", "[0-9]"))


class Encoder:
    """ids of texts as little-endian numbers of `dtype`, which is as narrow as the vocabulary allows."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str()[:4000]
        # of each token the bytes it stands for, or whether it ends a word
        self.mark = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.mark[i] = token.endswith("</w>") if self.by_word else len(token)
        self.cut_plain = _latin(WORDS if self.by_word else BYTE_LEVEL).findall
        self.cut_any = _split_ascii if self.by_word else regex.compile(BYTE_LEVEL).findall
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if "<|" in text and any(s in text for s in self.special):
            return [text]
        if PLAIN.fullmatch(text):
            return self.cut_plain(text.lower() if self.by_word else text)
        return self.cut_any(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = list(map(self.pieces, texts))
        if len(self.known) > REMEMBER:
            self.known.clear()
        # one look-up of each piece; what is not known yet is put in its place afterwards
        got = [list(map(self.known.get, ps)) for ps in pieces]
        gaps = [[i for i, ids in enumerate(found) if ids is None] for found in got]
        self.learn({ps[i] for ps, at in zip(pieces, gaps, strict=True) for i in at})
        for ps, found, at in zip(pieces, got, gaps, strict=True):
            for i in at:
                found[i] = self.known[ps[i]]
        return list(map(b"".join, got))

    def learn(self, new: set[str]) -> None:
        # pieces of a letter or a space and a letter stay apart when spaces stand between or before them
        joinable, alone = [], []
        for p in new:
            (joinable if (p.isalpha() if self.by_word else p[0] == " " and p[1:].isalpha()) else alone).append(p)
        for at in range(0, len(joinable), TOGETHER):
            self._together(joinable[at : at + TOGETHER])
        for at in range(0, len(alone), 4096):  # whole encodings are large, ids are small
            self._apart(alone[at : at + 4096])

    def _apart(self, part: list[str]) -> None:
        for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, dtype=self.dtype).tobytes()

    def _together(self, part: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.by_word else "").join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        done = np.cumsum(self.mark[ids])
        want = np.arange(1, len(part) + 1) if self.by_word else np.cumsum([len(p.encode()) for p in part])
        ends = np.searchsorted(done, want)
        if not len(ids) or done[-1] != want[-1] or (done[np.minimum(ends, len(done) - 1)] != want).any():
            self._apart(part)
            return
        data, size, start = ids.tobytes(), ids.itemsize, 0
        for p, end in zip(part, ((ends + 1) * size).tolist(), strict=True):
            self.known[p] = data[start:end]
            start = end


_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _split_ascii(text: str) -> list[str]:
    return [w for w in text.translate(_SPACES).split(" ") if w]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder of a file: it stays between tasks."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def chunks(batch, most_bytes: int = 1 << 20):
    """Row ranges of a record batch whose texts hold about most_bytes together."""
    texts = batch.column("text").to_pylist()
    at, size, part = 0, 0, []
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most_bytes:
            yield at, part
            at, size, part = at + len(part), 0, []
    if part:
        yield at, part
