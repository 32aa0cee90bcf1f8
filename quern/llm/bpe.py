"""Byte-level BPE by the tokenizers library, with a bounded cache of what stands between spaces.

The pre-tokenizer never joins characters across a space that a non-space follows: such a space
always starts a pre-token. So a text may be cut before each of them, and each distinct chunk be
encoded once. Texts are looked at together: their chunks are told apart by Arrow, each distinct one is looked up
once, and the library gets the new ones many at a time. The cache is exact; ``tests/llm/test_bpe_tokenbin_packing.py``
holds it against whole-text encoding.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space that does not surely start a pre-token: white space or the end follows. It is held as a character that no text
# has (texts with it are encoded whole), so that a text may be cut before all other spaces.
_ODD_SPACE = re.compile(r" (?!\S)")
HELD = "\uffff"


# Runs that are pre-tokens of their own: letters, digits, marks (no apostrophe, which may start a contraction), a lone line break.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?=\S)")
# The same in chunks that have a space before them, and chunks of nothing else.
_SPACED = re.compile(rf" ?(?:{_PARTS.pattern})")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ0-9!-&(-/:-@\[-`{-~]++(?:\n[A-Za-zÀ-ÖØ-öø-ɏ0-9!-&(-/:-@\[-`{-~]++)*+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level BPE writes byte b as a printable character: itself, or the next from 256 on.
_PRINTED = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: Bytes that no UTF-8 has, so that a vocabulary has hardly use for them.
_UNUSED = [0xC0, 0xC1, *range(0xF5, 0x100)]

#: Characters of texts that are looked at together, and new chunks that the library gets as one text.
GROUP, TOGETHER = 1 << 23, 128

#: Times that late chunks fill their room until all are forgotten.
TURNS = 16


class ChunkEncoder:
    """Encodes texts to little-endian uint32 ids.

    Strings of special tokens in a text become these tokens, as the library has it, or with ``special_as_text`` ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, max_chunks: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts that hold one of these are encoded whole.
        self.apart = (HELD, *(t.content for t in added if not (special_as_text and t.special)))
        self.max_chunks = max_chunks
        #: Those that came first, among which common ones are, stay; others go to late, which is emptied when it is full.
        self.chunks: dict[str, bytes] = {}
        self.late: dict[str, bytes] = {}
        self.turns = 0
        self.parts: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        #: Whether a token starts with a space: of chunks, only their first does.
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(_PRINTED[32])]] = True
        #: The model alone merges nothing across a byte that is in no other token, so that it may stand between pre-tokens.
        used = {c for t in vocab if len(t) > 1 for c in t}
        free = [_PRINTED[b] for b in _UNUSED if _PRINTED[b] in vocab and _PRINTED[b] not in used]
        simple = isinstance(self.model, BPE) and not any(getattr(self.model, k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        self.bare = Tokenizer(self.model) if simple and free else None
        if self.bare:
            self.between = vocab[free[0]]
            #: Code points of bytes as printed; zero, which no part holds, is what stands between.
            self.printed = np.array([ord(_PRINTED[b]) for b in range(256)], "<u4")
            self.printed[0] = ord(free[0])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> pa.Array:
        new = pa.array(list(map(self.late.get, missing)), pa.large_binary())
        if new.null_count:
            new = _filled(new, lambda holes: self._chunks([missing[k] for k in holes.tolist()]))
        n = min(len(missing), self.max_chunks * 3 // 4 - len(self.chunks))
        pairs = zip(missing, new.to_numpy(zero_copy_only=False).tolist(), strict=True)
        self.chunks.update(itertools.islice(pairs, n))
        room = self.max_chunks // 4 - len(self.late)
        self.late.update(itertools.islice(pairs, room))
        if len(missing) - n > room:
            self.late.clear()
            self.turns += 1
            if self.turns == TURNS:  # the texts may be others by now
                self.chunks.clear()
                self.parts.clear()
                self.turns = 0
            self.late.update(itertools.islice(pairs, self.max_chunks // 4))
        return new

    def _chunks(self, chunks: list[str]) -> pa.Array:
        """The ids of each chunk with a space before it, by few calls of the library."""
        plain, others, alone = [], [], []
        for n, x in enumerate(chunks):
            (plain if self.bare and _PLAIN.fullmatch(x) else alone if HELD in x else others).append(n)
        found, places = [], []
        for own, encode in ((plain, self._by_model), (others, self._by_library), (alone, None)):
            if own:
                found.append(self._together([chunks[n] for n in own], encode))
                places += own
        back = np.empty(len(chunks), np.int64)
        back[places] = np.arange(len(chunks))
        return pa.concat_arrays(found).take(pa.array(back))

    def _together(self, chunks: list[str], encode: Callable[[list[str]], np.ndarray] | None) -> pa.Array:
        if encode:
            ids = encode([" " + " ".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)])
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(chunks) and at[0] == 0:  # a token of its own for each space
                return pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(np.append(at, len(ids)) * 4), pa.py_buffer(ids)])
        return pa.array([self.whole(" " + x.replace(HELD, " ")) for x in chunks], pa.large_binary())

    def _by_library(self, texts: list[str]) -> np.ndarray:
        return _ids(self.tokenizer, texts)

    def _by_model(self, texts: list[str]) -> np.ndarray:
        """Of texts that only parts that surely are pre-tokens make up."""
        cut = ["\0".join(_SPACED.findall(x)).encode() for x in texts]
        printed = [self.printed[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in cut]
        ids = _ids(self.bare, printed)
        return ids[ids != self.between]

    def _chunk(self, x: str, lead: str) -> bytes:
        """The ids of lead (a space or nothing) and x."""
        found = _PARTS.findall(x)
        if not found or sum(map(len, found)) != len(x):  # not only of parts that surely are pre-tokens
            return self.whole(lead + x)
        found[0] = lead + found[0]
        ids = b""
        for part in found:
            if (known := self.parts.get(part)) is None:
                known = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_PRINTED))]).tobytes()
                if len(self.parts) < self.max_chunks // 2:
                    self.parts[part] = known
            ids += known
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        rows: list[tuple[int, str]] = []
        for n, text in enumerate(texts):
            if any(x in text for x in self.apart):
                out[n] = self.whole(text)
                continue
            first, space, rest = _ODD_SPACE.sub(HELD, text).partition(" ")
            out[n] = self._chunk(first.replace(HELD, " "), "") if first else b""  # the first has no space before it
            if space:
                rows.append((n, rest))
        if not rows:
            return out
        words = pc.split_pattern(pa.array([x for _, x in rows], pa.large_string()), " ")
        at, found = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        chunks, index = found.dictionary.to_numpy(zero_copy_only=False), found.indices
        ids = pa.array(list(map(self.chunks.get, chunks.tolist())), pa.large_binary())
        if ids.null_count:
            ids = _filled(ids, lambda holes: self._learn(chunks[holes].tolist()))
        taken = ids.take(index)
        data, ends = memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[at].tolist()
        for (n, _), a, b in zip(rows, ends, ends[1:], strict=False):
            out[n] = b"".join((out[n], data[a:b]))
        return out


def _ids(tokenizer, texts: list[str]) -> np.ndarray:
    few = (texts[i : i + 16] for i in range(0, len(texts), 16))  # what the library makes of a text is much larger than its ids
    return np.concatenate([np.array(x.ids, "<u4") for own in few for x in tokenizer.encode_batch_fast(own, add_special_tokens=False)])


def _filled(values: pa.Array, more: Callable[[np.ndarray], pa.Array]) -> pa.Array:
    """The array with what more gives for the places of nulls."""
    holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False))
    place = np.arange(len(values))
    place[holes] = len(values) + np.arange(len(holes))
    return pa.concat_arrays([values, more(holes)]).take(pa.array(place))


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker, vocabulary and mode."""
    return ChunkEncoder(path, special_as_text)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token."""
    from tokenizers import Tokenizer

    char = {c: b for b, c in _PRINTED.items()}
    t = Tokenizer.from_file(path)
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        out[i] = bytes(char[c] for c in token) if all(c in char for c in token) else token.encode()
    return out
