"""Whole-text encoding with the ``tokenizers`` library, memoised by text chunk.

A text is cut only where no token can cross, so that equal chunks are encoded once
for each Python worker. Texts for which that isn't certain go to the library whole, and so
do those that hold an added token of the vocabulary, such as ``<|endoftext|>``, which the
library takes for that one token.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker remembers at most, about 130 MB.
CHUNK_LIMIT = 650_000
#: Longer chunks aren't remembered, so that what a worker holds is bounded in bytes as well.
LONGEST = 64
#: Characters for which chunking was proven: ASCII without odd controls, Latin letters, dashes and quotes.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]")
#: White space that isn't one space or line feed between others; searched for plainly, which is quicker.
_RUNS = ("\t", "\r", "  ", "\n\n", " \n", "\n ")


#: Marks that are a token of their own behind a word.
TAILS = ",.;:!?"


def word_chunks(texts: list[str]) -> pa.ListArray:
    """Chunks for a tokenizer that drops white space: words."""
    return pc.ascii_split_whitespace(pa.array(texts, pa.string()))


def byte_chunks(texts: list[str]) -> pa.ListArray:
    """Chunks for a byte-level tokenizer whose tokens may begin with one space.

    A cut stands before a single space between two other characters, and on both sides
    of a single line feed: the pattern of such tokenizers lets a space only lead a
    token, and a line feed between other characters is a token of its own.
    """
    marked = [x.replace("\n", "\x00\n\x00").replace(" ", "\x00 ") for x in texts]
    return pc.split_pattern(pa.array(marked, pa.string()), "\x00")


def whole_word(text: str) -> bool:
    return _ODD.search(text) is not None


def whole_byte(text: str) -> bool:
    if _ODD.search(text) is not None or text.startswith((" ", "\n")) or text.endswith((" ", "\n")):
        return True
    return any(run in text for run in _RUNS)  # no other white space is left


def split_stems(chunks: list[str], words: bool) -> tuple[list[str], list[str], list[bool]]:
    """Each chunk as a stem, letters alone (behind a space if not ``words``) in the case that
    counts, and the mark behind it or nothing. A chunk that isn't so made is its own stem."""
    whole = pa.array(chunks, pa.string())
    word = pc.utf8_lower(whole) if words else whole
    last = pc.utf8_slice_codeunits(word, -1)
    marked = pc.is_in(last, pa.array(list(TAILS)))
    stem = pc.if_else(marked, pc.utf8_slice_codeunits(word, 0, -1), word)
    letters = stem if words else pc.utf8_slice_codeunits(stem, 1)
    plain = pc.utf8_is_alpha(letters)
    if not words:
        plain = pc.and_(plain, pc.starts_with(stem, " "))
    stem = pc.if_else(plain, stem, whole)
    tail = pc.if_else(pc.and_(plain, marked), last, "")
    return tuple(x.to_numpy(zero_copy_only=False).tolist() for x in (stem, tail, plain))


def encode_chunks(texts: list[str], chunks, whole, lookup, encode, kind) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the bounds of each text's.

    ``lookup`` gives the ids of distinct chunks as bytes; ``encode`` those of a text for
    which ``whole`` says that it must not be cut.
    """
    uncut = {i: np.frombuffer(encode(text), kind) for i, text in enumerate(texts) if whole(text)}
    cut = chunks(["" if i in uncut else text for i, text in enumerate(texts)])
    coded = cut.flatten().dictionary_encode()
    parts = lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    known = np.frombuffer(b"".join(parts), kind)
    chunk = coded.indices.to_numpy()
    n = sizes[chunk]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[chunk] - (ends - n)  # from place in the output to place in known
    place = np.int32 if len(known) + int(n.sum()) < 1 << 31 else np.int64
    at = np.repeat(first.astype(place), n)
    at += np.arange(len(at), dtype=place)
    ids = known[at]
    bounds = np.append(0, ends)[cut.offsets.to_numpy()]
    if uncut:
        each = [uncut.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        ids, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
    return ids, bounds


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    Most new chunks are stems: letters alone, in a byte-level vocabulary behind a space.
    They are encoded in one string, and the sign of a word's end or start in the token
    shows where each stem begins. Other chunks are encoded one by one.
    """

    def __init__(self, path: str, kind: str, limit: int = CHUNK_LIMIT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = kind == "word"
        self.chunks, self.whole = (word_chunks, whole_word) if self.words else (byte_chunks, whole_byte)
        self.limit, self.known = limit, {"": b""}
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.lead = os.path.commonprefix(added) if all(not x[:1].isalnum() for x in added) else ""
        self.lead = self.lead[: next((i for i, x in enumerate(self.lead) if x.isalpha()), len(self.lead))]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.stems = self.tokenizer
        if self.words:  # stems are lower-case letters already: nothing to normalise or to split but spaces
            self.stems = Tokenizer.from_file(path)
            self.stems.normalizer = None
            self.stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        tokens = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(tokens.values()) + 1, bool)
        self.edge[[i for x, i in tokens.items() if (x.endswith("</w>") if self.words else x.startswith("\u0120"))]] = True

    def uncut(self, text: str) -> bool:
        """Whether the library must see the text whole."""
        if self.added is not None and self.lead in text and self.added.search(text):
            return True
        return self.whole(text)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, together: list[str], alone: list[str]) -> None:
        """Remembers the ids of stems, encoded together, and of chunks that are none."""
        for at in range(0, len(together), 20_000):
            part = together[at : at + 20_000]
            text = (" " if self.words else "").join(part)
            ids = np.array(self.stems.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.edge[ids])
            ends = ends + 1 if self.words else np.append(ends[1:], len(ids))
            if len(ends) != len(part):
                alone += part
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(part, [data[i:j] for i, j in zip([0, *ends], ends)]))
        if alone:
            found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            self.known.update((x, np.array(y.ids, "<u4").tobytes()) for x, y in zip(alone, found))

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.limit:  # keep the older part: frequent chunks come early
            for key in list(known)[self.limit * 2 // 3 :]:
                del known[key]
        found = list(map(known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [chunks[i] for i in missing]
            stems, tails, plain = split_stems(new, self.words)
            fresh = {stem: letters for stem, letters in zip(stems, plain) if stem not in known}
            self._learn([x for x, letters in fresh.items() if letters], [x for x, letters in fresh.items() if not letters] + list(set(tails).difference(known, fresh)))
            full = known.__getitem__
            parts = list(map(bytes.__add__, map(full, stems), map(full, tails)))
            known.update(zip(new, parts))
            for i, ids in zip(missing, parts):
                found[i] = ids
            for i in [i for i, n in enumerate(map(len, new)) if n > LONGEST]:  # a stem is no longer than its chunk
                known.pop(new[i], None)
                if len(stems[i]) > LONGEST:
                    known.pop(stems[i], None)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = encode_chunks(texts, self.chunks, self.uncut, self._lookup, lambda text: self._ids(text).tobytes(), np.dtype("<u4"))
        return [ids[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str, limit: int = CHUNK_LIMIT) -> ChunkEncoder:
    """One encoder for each worker process; ``kind`` is ``word`` or ``byte``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, kind, limit)
